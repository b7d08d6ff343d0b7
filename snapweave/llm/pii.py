"""Personal data in texts, on DataFrame functions only.

Regular expressions propose spans; validators (Luhn, mod 97, numeric ranges) confirm them; words
shortly before or after a span raise its score. Base kinds (email, ip, card, phone) are kept by their
pattern and validator alone; further kinds (iban, ssn, tel, secret) need a score of ``MIN_SCORE``.
Secrets are values of well-known forms, and values assigned to a name like token or password that
are long hexadecimal numbers or of high entropy.

Patterns are written with possessive repeats, so that each scans a text in linear time and
without deep recursion, whatever the text holds; they match what the plain greedy forms match.
Each kind is searched only in texts that pass a cheaper test which all its matches imply (its guard).
Places come from the lengths of the pieces between matches, and context from the ends of the pieces
and matches around a span, so a text is never cut twice.

Defined results: null text counts as empty and has no spans; rows, repeated ones and those of
null doc_id too, keep all their columns (those named like a result are replaced). Matches that
a validator drops are not tried again at another place. Spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums

#: Score from which a span of a further kind counts.
MIN_SCORE = 0.7
#: Code points before a span, and after it, in which context words are looked for.
CONTEXT = 40
#: Matches of one kind that may stand in CONTEXT code points: each has two of its own at least.
_NEAR = CONTEXT // 2


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _digit(s: Column, i: Column) -> Column:
    return F.ascii(F.substr(s, i, F.lit(1))) - 48


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` have a valid Luhn check digit."""
    d = _digits(s)
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 0, (_digit(d, n + 1 - i) * 2) % 10 + F.floor(_digit(d, n + 1 - i) / 5).cast("int")).otherwise(_digit(d, n + 1 - i)),
    )
    return (n > 0) & (total % 10 == 0)


def mod97(s: Column) -> Column:
    """Whether an account number (letters count from 10) leaves 1 modulo 97, first four last."""
    c = F.regexp_replace(s, "[^A-Z0-9]", "")
    c = F.concat(F.substr(c, F.lit(5)), F.left(c, F.lit(4)))
    code = lambda i: F.ascii(F.substr(c, i, F.lit(1)))
    return (
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))),
            F.lit(0),
            lambda acc, i: F.when(code(i) >= 65, (acc * 100 + code(i) - 55) % 97).otherwise((acc * 10 + code(i) - 48) % 97),
        )
        == 1
    )


def _ip(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda s: F.length(_digits(s)).between(low, high)


def _ssn(s: Column) -> Column:
    return ~(s.rlike("^(000|666|9)") | F.substr(s, F.lit(5), F.lit(2)).eqNullSafe("00") | s.endswith("0000"))


def entropy(s: Column) -> Column:
    """Bits of entropy of a character of ``s``."""
    n = F.length(s).cast("double")
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, c: acc - F.when(c != "", share(c) * F.log2(share(c))).otherwise(F.lit(0.0)))


#: Bits of entropy of a character, and hexadecimal digits, from which an assigned value is a secret.
ENTROPY, HEX_DIGITS = 3.5, 32


def _secret(s: Column) -> Column:
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return s.rlike(f"^(?:{_TOKENS})") | s.rlike(f"^[0-9A-Fa-f]{{{HEX_DIGITS},}}$") | (mixed & (entropy(s) >= ENTROPY))


# Beginnings of well-known secrets, and the ends of names that secrets are assigned to.
_TOKENS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20}|xox[abprs]-[A-Za-z0-9-]{10}|sk-[A-Za-z0-9]{20}|eyJ[A-Za-z0-9_-]{10,}\.eyJ"
_NAMES = "token|secret|password|passwd|pwd|key|credential|credentials|Token|Secret|Password|Key|TOKEN|SECRET|PASSWORD|PASSWD|PWD|KEY|CREDENTIAL|CREDENTIALS"
_VALUE = r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.=-]{15,}+"

# Kind, guard (a text, a pattern, or several of which one is there), pattern, validator, score of a confirmed span,
# context words that raise it.
BASE = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.8, "mail|contact|write"),
    ("ip", re.compile(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.7, "ip|server|host|address"),
    ("card", re.compile(r"(?:[0-9][ -]?){11}[0-9]"), r"[0-9](?:[ -]?[0-9])++", lambda s: _between(12, 19)(s) & luhn(s), 0.8, "card|visa|credit|karte|carte|tarjeta"),
    ("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", _between(9, 15), 0.8, "phone|call|tel|mobile|fax"),
)
FURTHER = (
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8, "iban|account|konto|compte|cuenta"),
    ("ssn", re.compile(r"[0-9]-[0-9]{2}-[0-9]"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn, 0.5, "ssn|social security"),
    ("tel", re.compile(r"[0-9][ .-][0-9]{3}[ .-][0-9]"), r"(?<![0-9+().-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", None, 0.5, "phone|call|tel|mobile|fax"),
    ("secret", (re.compile(rf"""[:=][ "']{{0,2}}{_VALUE}"""), "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyJ"), rf"""(?<![A-Za-z0-9+/_.-])(?:(?<=(?:{_NAMES})["' ]{{0,2}}[:=][ "']{{0,2}}){_VALUE}|(?:{_TOKENS})[A-Za-z0-9+/_.=-]*+)""", _secret, 0.8, "token|secret|password|key"),
)
KINDS = tuple(k[0] for k in BASE + FURTHER)


def spans(text: Column, rank: int, kind: str, guard: str | re.Pattern | tuple, pattern: str, valid: Callable | None, score: float, context: str, least: float) -> Column:
    """All spans of one kind: array<struct<start, rank, kind, end, score>>."""
    words = rf"(?i)(?:^|[^a-z])(?:{context})"
    last, first = lambda s: F.right(s, F.lit(CONTEXT)), lambda s: F.left(s, F.lit(CONTEXT))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>")

    def near(z: Column, x: Column, i: Column) -> Column:
        low = F.greatest(i - _NEAR, F.lit(0))
        left = last(F.concat(F.array_join(F.slice(z["upto"], low + 1, i - low), ""), last(x["p"])))
        right = first(F.concat(first(x["r"]), F.array_join(F.slice(z["on"], i + 2, F.lit(_NEAR)), "")))
        return left.rlike(words) | right.rlike(words)

    def row(z: Column, x: Column, i: Column) -> Column:
        return F.struct(
            (x["b"] + F.length(x["p"])).alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (x["b"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
            F.when((valid or (lambda _: F.lit(True)))(x["m"]), F.when(near(z, x, i), F.lit(min(1.0, score + 0.2))).otherwise(F.lit(score))).otherwise(F.lit(0.0)).alias("score"),
        )

    # Each step binds what the next one reads several times, in an array of one, so it is computed once.
    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(F.array(value), then))

    def placed(w: Column) -> Column:
        own, rest = F.slice(w["pieces"], 1, F.size(w["found"])), F.slice(w["pieces"], 2, F.size(w["found"]))
        before = prefix_sums(F.zip_with(own, w["found"], lambda p, m: (F.length(p) + F.length(m)).cast("long")))
        # The ends of each match with the piece before it, and with the piece after it.
        upto = F.zip_with(own, w["found"], lambda p, m: last(F.concat(last(p), last(m))))
        on = F.zip_with(w["found"], rest, lambda m, p: first(F.concat(first(m), first(p))))
        each = F.arrays_zip(own.alias("p"), w["found"].alias("m"), before.alias("b"), rest.alias("r"))
        rows = bound(F.struct(each.alias("each"), upto.alias("upto"), on.alias("on")), lambda z: F.transform(z["each"], lambda x, i: row(z, x, i)))
        return F.filter(rows, lambda x: x["score"] >= least)

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    tests = [text.rlike(g.pattern) if isinstance(g, re.Pattern) else F.contains(text, F.lit(g)) for g in (guard if isinstance(guard, tuple) else (guard,))]
    may = reduce(lambda a, b: a | b, tests)
    return F.when(may, bound(cut, placed)).otherwise(empty)


def find_pii(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``base`` and ``entities`` (base spans and those of further kinds), arrays of
    struct<start, rank, kind, end, score> in the order of start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = {f"__{k[0]}": spans(text, i, *k, 0.1 if i < len(BASE) else min_score) for i, k in enumerate(BASE + FURTHER)}
    out = docs.drop("base", "entities").withColumns(each)
    base = F.array_sort(F.concat(*[F.col(f"__{k[0]}") for k in BASE]))
    out = out.withColumn("base", base)
    out = out.withColumn("entities", F.array_sort(F.concat("base", *[F.col(f"__{k[0]}") for k in FURTHER])))
    return out.drop(*each)


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with each entity of ``text`` replaced by its kind in angle brackets; of entities
    that overlap, the first one names the replacement. Null text stays null."""
    found = find_pii(docs, min_score)
    merged = F.aggregate(
        "entities",
        F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<string>").alias("parts")),
        lambda acc, e: F.when(
            e["start"] >= acc["to"],
            F.struct(
                e["end"].alias("to"),
                F.concat(acc["parts"], F.array(F.substr("text", acc["to"].cast("int") + 1, (e["start"] - acc["to"]).cast("int")), F.concat(F.lit("<"), e["kind"], F.lit(">")))).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(acc["to"], e["end"]).alias("to"), acc["parts"].alias("parts"))),
    )
    done = found.withColumn("__m", merged)
    whole = F.concat(F.array_join("__m.parts", ""), F.substr("text", F.col("__m.to").cast("int") + 1))
    return done.withColumn("text", F.when(F.size("entities") > 0, whole).otherwise(F.col("text"))).drop("__m")


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k[0]) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("entities")).alias("spans")
    )
