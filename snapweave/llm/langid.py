"""Language identification with spans of mixed-language text.

Every word gets a score per language from the byte trigrams in it, with counts learned from
labelled documents. The script of a word (by ranges of code points) narrows the languages to those
that use it in the labelled texts. Viterbi over the words, with a penalty for each switch, labels
the spans; the document's language is the one with most bytes of words on the best path. A text of
which no stretch of words gains more than the penalty in other languages keeps one label without
the search: the search would give the same path.

Learning reads up to about ``FIT_ROWS`` labelled documents of each language (chosen by a hash of
their text, so by rule and not by order); counts are summed per task and then per trigram, and the
table that tasks get is ``BUCKETS`` numbers for each language.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no spans; so is
every text if nothing could be learned. Rows pass with all columns, repeated rows and null doc_ids
too; columns named like a result are replaced. Ties go to the language first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import slices, trimmed

#: Labelled documents of each language from which the model is learned, about.
FIT_ROWS = 5000
#: Hash buckets of trigrams.
BUCKETS = 1 << 16
#: Cost of a switch of languages, in the natural log of a likelihood ratio.
PENALTY = 8.0
#: Least share of a language's script characters for the script to admit it.
SCRIPT_SHARE = 0.005
UND = "und"

# Scripts as ranges of code points (first, last).
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),), "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)), "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),), "gujarati": ((0xA80, 0xAFF),), "odia": ((0xB00, 0xB7F),), "tamil": ((0xB80, 0xBFF),), "telugu": ((0xC00, 0xC7F),), "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),), "sinhala": ((0xD80, 0xDFF),), "thai": ((0xE00, 0xE7F),), "lao": ((0xE80, 0xEFF),), "tibetan": ((0xF00, 0xFFF),), "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF),), "ethiopic": ((0x1200, 0x139F),), "khmer": ((0x1780, 0x17FF),), "mongolian": ((0x1800, 0x18AF),), "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
N_SCRIPTS = len(SCRIPTS)


def _script_table() -> np.ndarray:
    """Number of the script by the first two bytes of a character in UTF-8, [lead byte, next byte's six
    bits]; -1 for none. Of three bytes these are the 64 code points that share them, of four 4096."""
    lead, more = np.arange(256)[:, None], np.arange(64)[None, :]
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | more, np.where(lead < 0xF0, (lead & 15) << 12 | more << 6 | 32, (lead & 7) << 18 | more << 12 | 32)))
    out = np.full(point.shape, -1, np.int8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[(point >= a) & (point <= b)] = k
    return out


_SCRIPT = _script_table()
#: ASCII letters to lower case, bytes from 128 on kept, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words:
    """Words of some texts: where they are, their trigrams' buckets and their scripts."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
        solid = data != 32
        edge = np.flatnonzero(np.diff(solid.view(np.int8)))
        self.start, self.end = edge[::2] + 1, edge[1::2] + 1
        at = np.flatnonzero(solid)
        wide = data.astype(np.uint32)
        code = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
        self.codes = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
        self.length = self.end - self.start
        self.first = np.cumsum(self.length) - self.length  # of each word's trigrams
        self.begin = np.cumsum([len(r) + 1 for r in raw]) - np.array([len(r) for r in raw]) if raw else np.zeros(0, int)
        borders = np.searchsorted(self.start, np.append(self.begin, len(data)))
        self.counts = np.diff(borders)
        lead = np.where(data[at] >= 192, data[at], np.where(data[at] < 128, 0x61, 0))  # 0: within a character
        script = _SCRIPT[lead, data[at + 1] & 63]
        self.script = np.maximum.reduceat(script, self.first) if len(at) else np.zeros(0, np.int8)
        self.data = data


def _count(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(index), BUCKETS + N_SCRIPTS), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                w = Words(texts[a:b])
                lang = np.repeat([index[x] for x in langs[a:b]], w.counts)
                each = np.repeat(lang, w.length).astype(np.int64)
                size = BUCKETS + N_SCRIPTS
                sums += np.bincount(each * size + w.codes, minlength=sums.size).reshape(sums.shape)
                known = w.script >= 0
                sums += np.bincount(lang[known] * size + BUCKETS + w.script[known], minlength=sums.size).reshape(sums.shape)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket], pa.int64())], ["lang", "bucket", "n"])

    return run


class Model:
    """Languages, the score of each trigram bucket in each, and the scripts they use."""

    def __init__(self, langs: list[str], sums: np.ndarray):
        self.langs = langs
        own, scripts = sums[:, :BUCKETS].astype(float), sums[:, BUCKETS:].astype(float)
        smooth = np.log((own + 0.5) / (own.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
        self.table = np.ascontiguousarray((smooth - smooth.mean(axis=0)).T.astype(np.float32))
        self.admits = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
        self.admits[~self.admits.any(axis=1)] = True  # a script nobody uses tells nothing

    def scores(self, w: Words) -> np.ndarray:
        """[words, languages]; a language that the script does not admit is far behind."""
        if not len(w.codes):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.table[w.codes], w.first, axis=0)
        return np.where(self.admits[np.maximum(w.script, 0)] | (w.script < 0)[:, None], out, np.float32(-30.0))


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from ``docs(text, lang)``; rows without either are ignored. None without rows."""
    ship(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    langs = sorted(counts)
    part = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_rows / counts[k]))])
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(3)), 1) / float(1 << 63)
    some = labelled.where(draw <= F.element_at(part, F.col("lang")))
    sums = np.zeros((len(langs), BUCKETS + N_SCRIPTS), np.int64)
    found = some.mapInArrow(trimmed(_count({k: i for i, k in enumerate(langs)})), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums[found.column("lang").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Model(langs, sums)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word; texts (of ``counts`` words each, in sequence) go side by side."""
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    steps = int(counts.max(initial=0))
    alive = np.searchsorted(-counts[order], -np.arange(steps), "left")
    best = np.zeros((len(counts), scores.shape[1]))
    stay = np.ones(scores.shape, bool)
    come = np.zeros(len(scores), np.int32)
    for t in range(steps):
        at = begin[order[: alive[t]]] + t
        now = best[: alive[t]]
        if t:
            top = now.argmax(axis=1)
            jump = np.take_along_axis(now, top[:, None], 1) - penalty
            stay[at], come[at] = now >= jump, top
            now = np.maximum(now, jump)
        best[: alive[t]] = now + scores[at]
    label = np.zeros(len(scores), np.int32)
    cur = best.argmax(axis=1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        at = begin[order[: alive[t]]] + t
        label[at] = own = cur[: alive[t]]
        cur[: alive[t]] = np.where(stay[at, own], own, come[at])
    return label


def best_path(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """As ``viterbi``. One label is best for a whole text if no stretch of words gains more than
    one penalty by the best other labels; only other texts are searched."""
    doc = np.repeat(np.arange(len(counts)), counts)
    full = counts > 0
    sums = np.zeros((len(counts), scores.shape[1]))
    if not len(scores):
        return np.zeros(0, np.int32)
    sums[full] = np.add.reduceat(scores.astype(np.float64), (np.cumsum(counts) - counts)[full], axis=0)
    label = sums.argmax(axis=1).astype(np.int32)[doc]
    if scores.shape[1] == 1:
        return label
    own = np.take_along_axis(scores, label[:, None], 1)[:, 0].astype(np.float64)
    others = scores.copy()
    np.put_along_axis(others, label[:, None], -np.inf, 1)
    gain = np.cumsum(others.max(axis=1) - own)
    before = np.concatenate(([0.0], gain[:-1]))
    apart = doc * (2 * np.abs(gain).max() + 1.0)  # the least value so far starts anew in each text
    rise = gain - apart - np.minimum.accumulate(before - apart)
    mixed = np.zeros(len(counts), bool)
    np.logical_or.at(mixed, doc[rise > penalty - 1e-6], True)
    if mixed.any():
        own_words = mixed[doc]
        label[own_words] = viterbi(scores[own_words], counts[mixed], penalty)
    return label


_SPANS = "array<struct<lang:string,start:bigint,end:bigint>>"


def _predict(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            letters = batch.column(names.index("__letter")).to_pylist()
            texts = [t if ok else "" for t, ok in zip(texts, letters, strict=True)]
            lang, score, found = [], [], []
            for a, b in slices([len(t) for t in texts]):
                w = Words(texts[a:b])
                s = model.scores(w)
                label = best_path(s, w.counts)
                doc = np.repeat(np.arange(b - a), w.counts)
                n_langs = len(model.langs)
                mass = np.bincount(doc * n_langs + label, w.length, (b - a) * n_langs).reshape(b - a, n_langs)
                top = mass.argmax(axis=1)
                sure = np.exp(s - s.max(axis=1, keepdims=True)) if len(s) else s
                sure = sure[np.arange(len(s)), top[doc]] / sure.sum(axis=1) if len(s) else np.zeros(0)
                total = mass.sum(axis=1)
                mean = np.bincount(doc, sure * w.length, b - a) / np.maximum(total, 1)
                lang += [model.langs[k] if n else UND for k, n in zip(top.tolist(), total.tolist(), strict=True)]
                score += np.clip(mean, 0, 1).tolist()
                if spans:
                    found += _cut(w, label, doc, b - a, model.langs)
            new = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            if spans:
                new["spans"] = pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            keep = [n for n in names if n != "__letter"]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(n)) for n in keep] + list(new.values()), keep + list(new))

    return run


def _cut(w: Words, label: np.ndarray, doc: np.ndarray, n: int, langs: list[str]) -> list[list[dict]]:
    """Spans of equal labels, in code points from the start of each text."""
    out: list[list[dict]] = [[] for _ in range(n)]
    if not len(doc):
        return out
    points = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    turn = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1]))))
    last = np.append(turn[1:], len(doc)) - 1
    for i, j in zip(turn.tolist(), last.tolist(), strict=True):
        zero = points[w.begin[doc[i]]]
        out[doc[i]].append({"lang": langs[label[i]], "start": int(points[w.start[i]] - zero), "end": int(points[w.end[j]] - zero)})
    return out


def predict(docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score (mean certainty of its words for that language) and, if
    asked for, spans: array<struct<lang, start, end>> in code points."""
    docs = docs.drop("lang_pred", "score", "spans", "__letter")
    if model is None:
        out = docs.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
        return out.withColumn("spans", F.array().cast(_SPANS)) if spans else out
    ship(docs.sparkSession)
    marked = docs.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
    schema = (schema.withColumn("spans", F.array().cast(_SPANS)) if spans else schema).schema
    return marked.mapInArrow(trimmed(_predict(docs.sparkSession.sparkContext.broadcast(model), spans)), schema)


def fold(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", spans.alias("spans"))


def identified(docs: DataFrame, least: float = 0.2, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents, with their own columns, that have letters and on whose words the model is
    certain enough; learned from the labels they carry themselves. Without labels all stay that have letters."""
    model = learn(docs, fit_rows)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    marked = predict(docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c != "text"}), model, spans=False)
    kept = marked.where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return kept.select(*[F.col(c if c == "text" else f"__own_{c}").alias(c) for c in docs.columns])
