"""Operators on texts: nothing that a text holds is left out."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from snapweave.llm import chat, licenses, pii


def whole(template, ids):
    """All occurrences, none over another, by alignment with all of the text."""
    got = licenses.align(template, ids, -len(template), len(ids)) if ids else None
    if not got or got[0] < licenses.COVERAGE * len(template):
        return []
    n, a, b = got
    return whole(template, ids[:a]) + [(n, a, b)] + [(m, x + b, y + b) for m, x, y in whole(template, ids[b:])]


def test_adjacent_licenses():
    index, rnd = licenses.Index(licenses.TEMPLATES), random.Random(4)
    texts = ["All rights reserved. All rights reserved.", "Released under the MIT License.\n" * 40, "All rights reserved. " * 100]
    for name in licenses.TEMPLATES:
        own = licenses.TEMPLATES[name].split()
        for _ in range(10 if len(own) < 20 else 2):
            parts = []
            for _ in range(rnd.randrange(1, 7)):
                cut = 4 < len(own) < 20 and rnd.randrange(3)  # a long one would take the word from beyond the band
                parts += [*(own[1:] if cut == 1 else own[:-1] if cut == 2 else own), *["zzz"] * rnd.choice((0, 0, 1, 3, 9))]
            texts.append(" ".join(parts))
    for text, found in zip(texts, licenses.scan_shard(texts, index), strict=True):
        ids = [index.vocabulary.get(w, 0) for w in licenses.words(text)]
        for t, name in enumerate(index.names):
            want = whole(index.texts[t], ids)
            got = [(m["matched"], len(licenses.words(text[: m["start"]])), len(licenses.words(text[: m["end"]]))) for m in found if m["license"] == name]
            assert got == want, (name, text)
    assert [len(f) for f in licenses.scan_shard(texts[:3], index)] == [2, 40, 100]


def test_context_of_personal_data(spark):
    rnd = random.Random(6)
    fixed = [
        "my ssn 123-45-6789 and 234-56-7890", "call 555-123-4567 or 555-765-4321 or 555-222-3333", "123-45-6789, 234-56-7890 are social security numbers",
        "555-123-4567 (mobile)", "ssn 000-45-6789 123-45-6789", "no 123-45-6789 or 555-123-4567", "é😀 tel " + "x" * 36 + " 555-123-4567", "😀 tel " + "é" * 35 + " 555-123-4567",
        "card 4111111111111111 4111 1111 1111 1111 1 1 22 33", "a@b.c a@b.d mail",
    ]
    parts = ["ssn ", "call ", "hotel ", "é😀 ", "xx ", "yyyyyyyyyyyyyyyy ", "123-45-6789 ", "000-12-3456 ", "555-123-4567 ", "a@b.c ", "1.2.3.4 ", "+49301234567 ", "12 ", "4111111111111111, "]
    texts = fixed + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(300)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    kinds = {k[0]: k for k in pii.BASE + pii.FURTHER}
    for r in got:
        have = {(e.kind, e.start, e.end): e.score for e in r.entities}
        for kind, score in (("ssn", 0.5), ("tel", 0.5), ("email", 0.8)):
            want = {}
            for m in re.finditer(kinds[kind][2].replace(r"\G|", ""), r.text):
                sides = r.text[max(0, m.start() - pii.CONTEXT) : m.start()], r.text[m.end() : m.end() + pii.CONTEXT]
                near = any(re.search(f"(?i)(?:^|[^a-z])(?:{kinds[kind][5]})", s) for s in sides)
                if not m[0].startswith("000") and score + 0.2 * near >= (pii.MIN_SCORE if kind in ("ssn", "tel") else 0):
                    want[(kind, m.start(), m.end())] = min(1.0, score + 0.2 * near)
            assert {k: v for k, v in have.items() if k[0] == kind} == want, (kind, r.text)
    docs = spark.createDataFrame([(0, fixed[0]), (1, fixed[1])], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["my ssn <ssn> and <ssn>", "call <tel> or <tel> or <tel>"]


def test_chats_with_very_long_texts(spark):
    n = 21_000_000
    forms = [
        ('{"messages":[{"role":"user","content":"', '"},{"role":"assistant","content":"ok"}]}'), ('{"conversations":[{"from":"human","value":"', '"},{"from":"gpt","value":"ok"}]}'),
        ('{"data":{"turns":[{"speaker":"human","utterance":"', '"},{"speaker":"bot","utterance":"ok"}]}}'), ('{"prompt":"', '","response":"ok"}'), ('{"output":"ok","input":"","instruction":"', '"}'),
    ]
    none = [('{"unknown":"', '"}'), ('{"prompt":{"a":"', '"},"response":"ok"}'), ('{"messages":"', '"}'), ('{"prompt":"', '", no json')]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(forms + none)], "id int, a string, b string").repartition(9)
    records = df.select("id", F.concat("a", F.repeat(F.lit("x"), F.lit(n)), "b").alias("record"))
    turns = F.transform("turns", lambda t: F.concat_ws(":", t["role"], F.length(t["text"])))
    got = {r.id: (r.layout, r.t) for r in chat.canonical(records).select("id", "layout", turns.alias("t")).collect()}
    layouts = ["messages", "shares", "nested", "prompt", "instruction"]
    assert got == {i: (name, [f"user:{n}", "assistant:2"]) for i, name in enumerate(layouts)} | {i: (None, []) for i in range(5, 9)}


def test_stages_keep_columns_named_like_results(spark, tmp_path):
    names = ["n_words", "matches", "n_lines", "n_removed", "component_id", "kept", "__key", "__id", "bytes", "a.b"]
    texts = ["a text of its own about rivers\nand hills and more", "another one about ships and the long sea", "\n".join(["one line", "two line", "three line", "four line"])]
    rows = [(i, t, len(t), *[f"{n} {i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.dedup_near, corpus_pipeline.remove_benchmark):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == rows, stage.__name__
