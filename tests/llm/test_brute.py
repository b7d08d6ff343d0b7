"""Operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapweave.llm import chat, common, decontaminate, embeddings, langid, licenses, line_dedup, minhash, mixing, toxicity
from snapweave.llm.common import components, prefix_sums, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, matches int"
CLASHES = "n extra cut passes key comp component links band least node root units bands pos gone th h1 taken copies n_hit items score spans layout u v a b n_words matches kept component_id n_lines n_removed size target".split()


def fold(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def prose(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = []
    for i in range(60):
        text = "\n".join(prose(rnd, rnd.randrange(2, 30)) for _ in range(rnd.randrange(1, 9)))
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "é", None]), len(text), "x", 7))
    for i in range(60, 90):  # near copies and copies
        base = out[rnd.randrange(30)][1].split(" ")
        if i % 3:
            base[rnd.randrange(len(base))] = "zzz"
        out.append((i, " ".join(base), "en", "a", None, "x", 7))
    out += [(90, None, None, None, None, None, None), (91, "", "en", "a", 0, "x", 1), (92, "   \n\n\n ", "en", "b", 3, "x", 1), (93, "one", "en", "b", 3, "x", 1)]
    out += [(None, "no id here, twice", "en", "b", 3, "x", 1)] * 2 + [out[0], out[0], (94, "x " * 30_000, "en", "c", 3, "x", 1), (95, "y" * 200_000, None, "c", 3, "x", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return df.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(request, monkeypatch, spark):
    """Either way of joining; without broadcasts as over tables too large for them."""
    if request.param == "shuffle":
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(minhash, "BLOCK", 3)
        monkeypatch.setattr(embeddings, "BLOCK", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- helpers ---


def test_prefix_sums(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1000)),)], "x array<long>")
    got = [r[0] for r in df.select(prefix_sums(F.col("x"))).collect()]
    assert got[0] == [] and got[1] == [0] and got[2] == [sum(range(i)) for i in range(1000)]


def test_word_hashes_are_of_the_words():
    a, n = word_hashes([b"to be or", b"", b"  not to  be", b"x"])
    assert n.tolist() == [3, 0, 3, 1]
    assert a[0] == a[4] and a[1] == a[5] and len(set(a.tolist())) == 5


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ---


def spans_of(text, items, window=10):
    w, hit, ids = fold(text), set(), set()
    for item, t in items:
        ws = fold(t)
        k = min(window, len(ws))
        for p in range(len(ws) - k + 1 if ws else 0):
            for q in range(len(w) - k + 1):
                if w[q : q + k] == ws[p : p + k]:
                    hit |= set(range(q, q + k))
                    ids.add(item)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None)


@pytest.mark.parametrize("block", [10**9, 40])
def test_decontamination(spark, docs, rows, block):
    a, b = fold(rows[3][1]), fold(rows[5][1])
    items = [(1, " ".join(a[2:20])), (1, " ".join(a[2:20])), (2, "ONE"), (30, " ".join(b[:12]).upper()), (4, ""), (5, None), (None, " ".join(b[4:15])), (6, "never there at all in any of these texts of ours")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_matches(docs, bench, block_bytes=block)
    covered, ids = decontaminate.n_covered(F.col("matches")), F.array_sort(F.array_distinct("items"))
    got = sorted(((r[0], r[1], r[2], r[3], r[4]) for r in out.select("doc_id", F.md5("text"), "n_words", covered, ids).collect()), key=str)
    want = sorted(((r[0], hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else None, *spans_of(r[1], items)) for r in rows), key=str)
    assert got == want
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.count() == sum(not w[3] for w in want) and "size" in kept.columns
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_repeated_words_and_longest_matches():
    """Against brute force on words that repeat; and long runs of one word in linear time."""
    rnd = random.Random(1)
    for _ in range(200):
        v, win = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 30]))], rnd.choice([2, 3, 5, 10])
        items = [(i, " ".join(rnd.choice(v) for _ in range(rnd.randrange(25)))) for i in range(rnd.randrange(6))]
        texts = [" ".join(rnd.choice(v + ["zz"] * rnd.randrange(3)) for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(1, 6))]
        texts += [f"zz {t} zz {t}" for _, t in items[:1]]
        block = decontaminate.Block(items, win)
        n, listed, found = decontaminate._shard(texts, block)
        for i, text in enumerate(texts):
            w, longest = fold(text), {}
            for _, t in items:
                ws = fold(t)
                for q, p in itertools.product(range(len(w)), range(len(ws) - min(win, len(ws)) + 1 if ws else 0)):
                    k = next((k for k in range(min(len(w) - q, len(ws) - p)) if w[q + k] != ws[p + k]), min(len(w) - q, len(ws) - p))
                    if k >= min(win, len(ws)):
                        longest[q] = max(longest.get(q, 0), k)
            got = {p: k for _, _, p, k in found.get(i, ())}
            assert got == {q: k for q, k in longest.items() if longest.get(q - 1, 0) <= k}
            assert all(w[p : p + k] == fold(items[[x for x, _ in items].index(block.ids[item])][1])[q : q + k] for item, q, p, k in found.get(i, ()))
            covered = {x for p, k in got.items() for x in range(p, p + k)}
            assert (n[i], len(covered), sorted(str(block.ids[x]) for x in listed.get(i, ()))) == spans_of(text, items, win)
    texts = ["ha " * 20_000, "ho " + "ha " * 30_000]
    _, listed, found = decontaminate._shard(texts, decontaminate.Block([(0, "ha " * 2000)], 10))
    assert len(found[0]) == 18_001 and len(found[1]) == 28_001 and listed == {0: [0], 1: [0]}


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + text + " c " + text)], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "q " + " ".join(f"w{i}" for i in range(5, 30)))], "item_id string, text string")
    found = decontaminate.find_matches(docs, bench).first().matches
    assert [(m.item_start, m.start, m.length) for m in sorted(found, key=lambda m: m.start)] == [(1, 7, 25), (1, 48, 25)]


# --- mixing ---


def test_fit_is_exact():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        n = int(rnd.integers(1, 8))
        lengths, counts = rnd.choice(40, n, replace=False), rnd.integers(1, 4, n)
        sums = {0}
        for length, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * length for s in sums for k in range(c + 1)}
        budget = int(rnd.integers(0, max(sums) + 1))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    lengths, counts = np.arange(1, 3000), np.full(2999, 900)
    take = mixing.fit(lengths, counts, 1_234_567_890)
    assert (take <= counts).all() and int((take * lengths).sum()) == 1_234_567_890


def test_mix(spark, docs, rows, joins):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and "matches" in got[0].asDict()
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w >= 2 * size[s]]
        for s in over or free:
            target[s] = 2.0 * size[s] if over else left * weight[s] / w
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= set(over)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        least = max((len((r[1] or "").split()) for r in rows if r[3] == s), default=0)
        assert abs(taken[s] - target[s]) <= max(1, least)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.text)[:50], r.taken) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- near-duplicates ---


def shingles(text):
    w = fold(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_minhash_classes(docs, rows, joins):
    got = minhash.classes(docs).collect()
    assert len(got) == len(rows)
    texts = sorted({r[1] for r in rows if r[1] is not None})
    bags = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, either = (bags[i] & bags[j]).total(), (bags[i] | bags[j]).total()
            if both and both >= 0.8 * either:
                root[find(i)] = find(j)
    least = {}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            k = find(texts.index(r[1]))
            least[k] = min(least.get(k, 10**9), r[0])
    for r in got:
        want = r.doc_id if r.text is None else least.get(find(texts.index(r.text)))
        assert r.component_id == want and r.kept == (r.doc_id == want), r.doc_id
    kept = minhash.dedup(docs).collect()
    assert len(kept) == len({find(i) for i in range(len(texts))}) + 1
    assert minhash.classes(docs.limit(0)).count() == 0


def test_darts_estimate_weighted_jaccard():
    rnd = np.random.default_rng(7)
    ids = rnd.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rnd.random(60) * 0.9 + 0.1, rnd.random(60) * 0.9 + 0.1
    units = np.concatenate([ids, ids])
    sig = minhash.signatures(units, np.repeat([0, 1], 60), 2, 4096, np.concatenate([a, b]))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


# --- lines ---


def test_line_dedup(docs, rows, joins):
    got = {(r.doc_id, r.text_old): (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs.withColumn("text_old", F.col("text"))).collect()}
    seen, gone = {}, {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = [x.strip(" \t\r") for x in t.split("\n")]
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(w) and seen.setdefault(w, (i, t, p)) != (i, t, p):
                gone.setdefault((i, t), set()).update(range(p, p + 3))
    for i, t in {(r[0], r[1]) for r in rows}:
        if t is None:
            assert got[i, t] == (0, 0, None)
            continue
        cut = gone.get((i, t), set())
        lines = t.split("\n")
        assert got[i, t] == (len(lines), len(cut), "\n".join(x for k, x in enumerate(lines) if k not in cut))
    assert gone and line_dedup.dedup_lines(docs.limit(0)).count() == 0


# --- chats ---


def test_chat_layouts_and_round_trip(spark):
    says = "</s>[INST] ok [/INST] <|end|> <\\|end|> <<SYS>> <|text|>"
    records = [
        '{"prompt": "a", "response": "b"}', '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"instruction":"a","input":"","output":"b"}',
        '{"data":{"turns":[{"speaker":"user","utterance":"a"},{"speaker":"bot","utterance":"b"}]}}', '{"question":"a","answer":"b"}',
        '{"instruction":"a","input":"x","output":"b"}', '{"unknown": 1}', "no json", None, '{"messages":[]}',
    ]
    df = spark.createDataFrame([(i, r, "t") for i, r in enumerate(records)], "id int, record string, turns string")
    got = [[(t.role, t.text) for t in r.turns] for r in chat.canonical(df).orderBy("id").collect()]
    two = [("user", "a"), ("assistant", "b")]
    assert got == [two] * 6 + [[("user", "a\n\nx"), ("assistant", "b")]] + [[]] * 4
    rows = [(1, 0, "user", says), (1, 1, "assistant", says), (1, 2, "assistant", None), (2, 0, None, "x"), (3, 1, "assistant", "é😀"), (3, 0, "sys<|text|>tem", ""), (None, 0, "user", "q"), (4, 0, "gpt", "r"), (4, 0, "gpt", "r")]
    done = chat.apply_template(chat.canonical(chat.to_records(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))))
    back = {r[0]: ([(t.role, t.text) for t in r[1]], r[2], r[3]) for r in done.select("conv_id", chat.read_back(F.col("formatted")), chat.masked(F.col("formatted"), F.col("mask")), "formatted").collect()}
    assert back[1][0] == [("user", says), ("assistant", says), ("assistant", "")] and back[1][1] == says
    assert back[1][2].count("</s>") == back[1][2].count("[INST]") == 0 and back[1][2].count("<|end|>") == 3
    assert back[2][:2] == ([("", "x")], "") and back[3][:2] == ([("sys<|text|>tem", ""), ("assistant", "é😀")], "é😀") and back[None][0] == [("user", "q")]
    assert back[4][0] == [("gpt", "r"), ("gpt", "r")] and len(back) == 5


# --- embeddings ---


def test_embeddings(spark, joins):
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(400):
        v = rnd.normal(size=16)
        if i % 4 == 1:
            v = np.array(rows[-1][1]) + rnd.normal(size=16) * rnd.choice([0.05, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 50 else None, "c"))
    rows += [(1000 + k, rows[5][1], rows[5][2], "c") for k in range(30)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1, "c"), (2001, [0.0] * 16, 1, "c"), (2002, [nan] + [1.0] * 15, 1, "c"), (2003, [inf] + [1.0] * 15, 1, "c"), (2004, [None] + [1.0] * 15, 1, "c"), (2005, [], 1, "c"), (2006, [1.0] * 3, 1, "c"), (2007, [2.0] * 3, 1, "c"), (2001, [0.0] * 16, 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string").repartition(4)
    df = df.withColumns({c: F.lit(c) for c in CLASHES})
    ok = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    n, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), r[0])
    want = sorted((r[0], n[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.link_vectors(df).collect())
    assert got == want and sum(n.values()) > 900
    assert embeddings.link_vectors(df.limit(0)).count() == 0


def test_e8_points_are_nearest():
    z = np.random.default_rng(1).normal(size=(300, 8)) * 3
    p = embeddings.decode(z)
    near = ((z[:, None] - p[:, None] - embeddings.ROOTS[None]) ** 2).sum(axis=2).min(axis=1)
    assert len(embeddings.ROOTS) == 240 and (((z - p) ** 2).sum(axis=1) <= near + 1e-9).all()


# --- licenses ---


def test_licenses_against_whole_alignment(spark):
    rnd = random.Random(9)
    index, texts = licenses.Index(licenses.TEMPLATES), [None, "", "All rights", "x " * 20_000, "mit license " * 500]
    for name in licenses.TEMPLATES:
        for drop in (0, 0, 1, 3):
            w = licenses.TEMPLATES[name].split()
            for _ in range(min(drop, len(w) // 8)):
                w[rnd.randrange(len(w))] = "zzz"
            texts.append(prose(rnd, 30) + " é " + " ".join(w) + " " + prose(rnd, 30))
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, matches int")
    for r in licenses.scan(docs).collect():
        ids = [index.vocabulary.get(w, 0) for w in licenses.words(r.text or "")]
        if len(ids) > 2000:
            continue
        for t, name in enumerate(index.names):
            whole = licenses.align(index.texts[t], ids, -len(index.texts[t]), len(ids)) if ids else None
            found = [m for m in r.matches if m.license == name]
            enough = whole is not None and whole[0] >= licenses.COVERAGE * len(index.texts[t])
            if r.text == texts[4]:
                continue
            assert bool(found) == enough, (name, r.text)
            if found:
                assert found[0].matched == whole[0] and len(found) == 1
                cut = r.text[found[0].start : found[0].end]
                assert len(licenses.words(cut)) == whole[2] - whole[1]


# --- toxicity and languages ---


def test_restoring_and_scores(spark):
    rnd = random.Random(2)
    bad = ["idiot", "moron", "worthless"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rnd, 40, "aeioutrnsl").split()
        if i % 4 == 0:
            w[rnd.randrange(40)] = rnd.choice(bad)
        rows.append((i, " ".join(w) if i else None, 1.5))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (None, "", 1.0), (7, "you w0rthle5s m.o.r.o.n iiiidiot", 1.0), (7, "x" * 100_000, 0.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    fix = toxicity.restorer(docs)
    assert fix.text("a m.o.r.o.n, iiiidiot! 2024") == "a moron, idiot! 2024"
    assert toxicity.restored(docs, fix).where("doc_id = 7").count() == 3
    model = toxicity.learn(docs, marks.where("doc_id % 5 <> 0"), fix)
    got = toxicity.score(docs, fix, model).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id > 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in own]) > 0.95
    assert [r.predicted for r in got if r.text == "you w0rthle5s m.o.r.o.n iiiidiot"] == [1]
    nothing = toxicity.learn(docs, marks.limit(0), fix)
    assert {r.predicted for r in toxicity.score(docs, fix, nothing).collect()} == {0}
    assert toxicity.score(docs.limit(0), fix, model).count() == 0


def test_paths_are_best():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        counts = rnd.integers(0, 30, 6)
        s = (rnd.normal(0, 3, (counts.sum(), 3)) + [2, 0, 0]).astype("f4")

        def value(label, counts=counts, s=s):
            total, k = 0.0, 0
            for n in counts:
                own = label[k : k + n]
                total += s[np.arange(k, k + n), own].sum() - langid.PENALTY * (own[1:] != own[:-1]).sum()
                k += n
            return total

        assert abs(value(langid.best_path(s, counts)) - value(langid.viterbi(s, counts))) < 1e-2


def test_label_sequences_by_enumeration():
    """The path of most score among all label sequences; ties have equal value."""
    rnd = np.random.default_rng(5)
    for _ in range(150):
        counts = rnd.integers(0, 7, 3)
        s = rnd.normal(0, 5, (counts.sum(), 3)).astype("f4")
        label, k = langid.best_path(s, counts), 0
        for n in counts.tolist():
            value = lambda path, k=k: sum(float(s[k + i, x]) for i, x in enumerate(path)) - langid.PENALTY * sum(x != y for x, y in zip(path, path[1:]))
            best = max(value(path) for path in itertools.product(range(3), repeat=n))
            assert abs(value(label[k : k + n].tolist()) - best) < 1e-3
            k += n


def test_scripts_of_words():
    cases = {"hello": "latin", "ñandú": "latin", "жук": "cyrillic", "λόγος": "greek", "नमस्ते": "devanagari", "สวัสดี": "thai", "ສະບາຍ": "lao", "தமிழ்": "tamil", "漢字": "han", "かな": "kana", "한글": "hangul", "שלום": "hebrew", "سلام": "arabic"}
    names = list(langid.SCRIPTS)
    assert [names[k] for k in langid.Words([" ".join(cases)]).script] == list(cases.values())


def test_lattices_by_enumeration():
    """The cheapest reading among all paths of a lattice, under any trigram costs."""
    rnd = np.random.default_rng(3)
    fix = toxicity.Restorer(rnd.integers(0, 50, toxicity.SYMBOLS**3).astype(float))

    def cost(text, extra):
        x = y = toxicity._BORDER
        for c in text:
            k = ord(c) - 97 if "a" <= c <= "z" else toxicity._OTHER
            extra += fix.cost[x][y][k]
            x, y = y, k
        return extra + fix.cost[x][y][toxicity._BORDER]

    for stretch in ["w0rthle5s", "m.o.r.o.n", "iiidiot", "1d10t", "a$$h*le", "b000m", "h3llo!!!", "x***y", "|1|1|", "b@$t@rd", "é3é", "(ra(k", "no000ob"]:
        ways = [("".join(t for t, _ in way), sum(e for _, e in way)) for way in itertools.product(*fix.lattice(stretch))]
        best = min(cost(t, e) for t, e in ways)
        got = fix.restore(stretch)
        assert any(t == got and abs(cost(t, e) - best) < 1e-9 for t, e in ways), stretch
    assert len(fix.lattice("b000m")) == 3 and len(fix.lattice("x***y")) == 5  # no mark is left out unread


def test_rows_dealt_for_one_large_group(spark, monkeypatch):
    """One bucket of near-duplicates around a centre, and one cell of vectors: what is dealt."""
    n, few = 4000, 10
    rows = [(7, bytes([i >> 8, i & 255]), 5, b"main" if i >= few else bytes([i])) for i in range(n)]
    placed = spark.createDataFrame([(b, bytearray(k), s, bytearray(c)) for b, k, s, c in rows], "band long, key binary, size long, comp binary")
    members = placed.join(minhash.outsiders(placed), "band")
    dealt = minhash.blocks(members)
    right = -(-n // minhash.BLOCK)
    assert dealt.count() == n + few * right  # not the square of the bucket
    pairs = Counter()
    for r in dealt.groupBy("band", "lo", "hi").agg(F.count_if("given").alias("a"), F.count_if(~F.col("given")).alias("b")).collect():
        pairs["dealt"] += r.a * r.b
    assert pairs["dealt"] == few * n
    cell = spark.range(n).select(F.lit(1).cast("long").alias("cell"), F.col("id").cast("string").alias("key"), *[F.lit(0).alias(c) for c in ("embedding", "label", "n", "cells")])
    assert embeddings.blocks(cell, spark.createDataFrame([(1, n)], "cell long, n_in long")).count() == n * -(-n // embeddings.BLOCK)
    tail = sum(math.comb(160, k) * 0.8**k * 0.2 ** (160 - k) for k in range(int(160 * minhash.SIEVE)))
    assert tail < 1e-8  # a pair of similarity 0.8 that the signatures sieve out


def test_languages(spark):
    rnd = random.Random(3)
    words = {"en": "the of and ing tion with hat".split(), "de": "der und sch ein lich keit ung".split(), "ru": "что это как его она они был".split()}
    make = lambda k, n: " ".join(rnd.choice(words[k]) + rnd.choice(words[k]) for _ in range(n))
    rows = [(i, make(k, 30), k, "s") for i, k in enumerate(["en", "de", "ru"] * 40)]
    odd = [(900, None, "en", "s"), (901, "12 34 …!", None, "s"), (902, "", "de", "s"), (None, make("de", 9), None, "s"), (903, make("en", 40) + " " + make("de", 60), None, "s")]
    docs = spark.createDataFrame(rows + odd + odd[:1], "doc_id long, text string, lang string, score string")
    got = langid.predict(docs, langid.learn(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 126 and all(by[i].lang_pred == k for i, _, k, _ in rows)
    assert [by[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "de", "de"]
    spans = by[903].spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - len(odd[4][1].split(" ", 40)[0])) < 400 and spans[1].end == len(odd[4][1])
    assert odd[4][1][spans[0].start : spans[0].end].count(" ") in range(37, 43)
    assert langid.learn(docs.where("lang = 'xx'")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.identified(docs).count() == 122 and langid.identified(docs.limit(0)).count() == 0
