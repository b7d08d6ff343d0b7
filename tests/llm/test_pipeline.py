"""The pipeline, stage by stage, against brute force; and registered queries on the small tables."""

import random
import re
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from test_brute import fold, prose, shingles, spans_of


def made(spark, folder):
    rnd = random.Random(8)
    rows = []
    for i in range(80):
        lines = [prose(rnd, rnd.randrange(4, 25), "etaoinshr") for _ in range(rnd.randrange(1, 8))]
        rows.append([i, "\n".join(lines), "en", f"s{i % 4}"])
    for i in range(80, 100):
        base = rows[rnd.randrange(40)][1].split(" ")
        base[rnd.randrange(len(base))] = "zzz"
        rows.append([i, " ".join(base), None, "s1"])
    items = [(k, " ".join(fold(rows[k][1])[1:13])) for k in (41, 45)]
    rows += [[100, "12 34 !!", "en", "s0"], [101, None, None, None], [102, "", "en", "s0"], [103, rows[50][1], "en", "s2"], [103, rows[50][1], "en", "s2"], [104, "x\ny\nz\n" + rows[51][1], "en", None], [105, "x\ny\nz", "en", "s3"]]
    docs = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def brute(docs, items):
    docs = [d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])]
    yield sorted(docs, key=str)
    seen, out = {}, []
    gone = {}
    for i, t in sorted({(d[0], d[1]) for d in docs}):
        lines = [x.strip(" \t\r") for x in t.split("\n")]
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(w) and seen.setdefault(w, (i, t, p)) != (i, t, p):
                gone.setdefault((i, t), set()).update(range(p, p + 3))
    for d in docs:
        cut = gone.get((d[0], d[1]), set())
        text = "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in cut)
        if text or not cut:
            out.append((d[0], text, d[2], d[3], len(text)))
    docs = out
    yield sorted(docs, key=str)
    texts = sorted({d[1] for d in docs})
    bags, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total() > 0:
                root[find(i)] = find(j)
    best = {}
    for d in sorted(docs, key=lambda d: d[0]):
        best.setdefault(find(texts.index(d[1])), d)
    docs = list(best.values())
    yield sorted(docs, key=str)
    docs = [d for d in docs if not spans_of(d[1], items)[2]]
    yield sorted(docs, key=str)


def test_stages(spark, tmp_path):
    docs, items = made(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES[:4], brute(docs, items), strict=True)):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert now.columns == columns, name
        assert sorted((tuple(r) for r in now.collect()), key=str) == want, name
    mixed = corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).collect()
    size, taken, target = Counter(), Counter(), {}
    for d in want:
        size[d[3]] += len(d[1].split())
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.copies in (1, 2) and r.source_size == size[r.source]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mixed))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = __spark_entry__.queries()
    own = [n for n in found if re.match(r"op\d+_|pipeline", n)]
    assert len(own) == 11
    for name in own:
        assert found[name](spark, str(tmp_path)).count() == (1 if name == "op6_chat" else 0), name


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = __spark_entry__.queries()["op10_langid"](spark, folder).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.98
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = __spark_entry__.queries()["op9_toxicity"](spark, folder).collect()
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert len(got) == len(docs) and np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.93
