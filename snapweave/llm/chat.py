"""Chat formatting by schema fingerprints, on DataFrame functions only.

Records come as JSON in whatever layout their source has. The field paths of each record, nested
ones included, make its fingerprint; fingerprints select a declarative mapping, which turns the
record into canonical turns (role, text). A template then writes the turns as one text, with
control strings around roles and texts, and a loss mask over what the assistant says. Control
strings inside roles and texts (those of this template and of other common ones) get a backslash
after their first character, one more than they have; taking one away gives the text back.

Defined results: null text and role count as empty. Records of an unknown fingerprint have no turns
and name no layout, so they can be counted; so have records that are null or not JSON. Rows pass with all columns, repeated rows and null ids too; columns named like a result are replaced. Turns of
one conversation come in the order of turn, then role, then text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums

# The template's control strings, and what is escaped inside texts.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"\||/?s>|<SYS>>|</SYS>>|/?INST\]"

#: Characters from which a record that is no variant is compared with the declared layouts.
LARGE = 8_000_000

#: Options of JSON readers: strings of any length.
_ANY_LENGTH = {"maxStringLen": "2147483647"}

_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: the field paths that name a layout, and how its turns are read.

    ``each`` is (array path, role field, text field); ``fields`` is (role, its fields) in order, where
    several fields that are not empty become one text."""

    name: str
    paths: tuple[str, ...]
    each: tuple[str, str, str] | None = None
    renames: bool = False  # whether other names of roles (ROLES) are usual in this layout
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Declared layouts; a layout with optional fields is declared once for each set of them.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), each=("messages", "role", "content")),
    Layout("messages", ("messages[].role", "messages[].text"), each=("messages", "role", "text")),
    Layout("shares", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), renames=True),
    Layout("nested", ("data.turns[].speaker", "data.turns[].utterance"), each=("data.turns", "speaker", "utterance"), renames=True),
    Layout("prompt", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt", ("prompt", "response", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)

#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value: Column) -> Column:
    """The nested field names of a variant as text: names in order, { opens an object, [ an array.

    The schema of OBJECT<a: STRING, b: ARRAY<OBJECT<c: BIGINT>>> without its types."""
    names = F.regexp_replace(F.schema_of_variant(value), r"(?:DECIMAL\([0-9,]*\)|[A-Z_]+)(?=[,>]|$)", "")
    return F.regexp_replace(F.regexp_replace(names, "ARRAY<", "["), "OBJECT<", "{")


def _shape(paths: tuple[str, ...]) -> str:
    """The shape text of declared paths: names in order, { for objects and [ for arrays."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})

    def write(node: dict) -> str:
        if not node:
            return ""
        if set(node) == {"[]"}:
            return "[" + write(node["[]"]) + ">"
        return "{" + ", ".join(f"{k}: {write(node[k])}" for k in sorted(node)) + ">"

    return write(tree)


def _large_shape(record: Column) -> Column:
    """The shape of the declared layout that a record too large for a variant has, or null."""

    def names(schema: str, *path: str) -> Column:
        at = F.from_json(record, schema, _ANY_LENGTH)
        for k in path:
            at = at[k]
        return F.array_sort(F.map_keys(at))

    shape = F.lit(None).cast("string")
    for own in LAYOUTS:
        top = F.array(*[F.lit(n) for n in sorted({p.replace("[]", "").split(".")[0] for p in own.paths})])
        fits = names("map<string,string>") == top
        if own.each:
            path, role, text = own.each
            schema, outer = "array<map<string,string>>", path.split(".")
            for depth in range(1, len(outer)):
                own_schema = "map<string,string>"
                for k in reversed(outer[:depth]):
                    own_schema = f"struct<`{k}`:{own_schema}>"
                fits &= names(own_schema, *outer[:depth]) == F.array(F.lit(outer[depth]))
            for k in reversed(outer):
                schema = f"struct<`{k}`:{schema}>"
            items = F.from_json(record, schema, _ANY_LENGTH)
            for k in outer:
                items = items[k]
            inner = F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(F.map_keys(x), F.array().cast("array<string>"))))))
            fits &= inner == F.array(*[F.lit(n) for n in sorted((role, text))])
        else:  # texts, no objects or arrays
            for kind in ("map<string,string>", "array<string>"):
                row = F.from_json(record, ",".join(f"`{n}` {kind}" for n in own.paths), _ANY_LENGTH)
                for n in own.paths:
                    fits &= row[n].isNull()
        shape = F.when(fits, F.lit(_shape(own.paths))).otherwise(shape)
    return shape


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record; null if it is no JSON."""
    paths = field_paths(F.try_parse_json(record))
    return F.xxhash64(F.when(paths.isNull() & (F.length(record) > LARGE), _large_shape(record)).otherwise(paths))


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, role), role)


def _read(layout: Layout, record: Column) -> Column:
    """Canonical turns of a record of this layout."""
    if layout.each:
        path, role, text = layout.each
        schema, outer = f"array<struct<`{role}`:string,`{text}`:string>>", path.split(".")
        for k in reversed(outer):
            schema = f"struct<`{k}`:{schema}>"
        items = F.from_json(record, schema, _ANY_LENGTH)
        for k in outer:
            items = items[k]
        return F.transform(items, lambda x: F.struct((_role(x[role]) if layout.renames else F.coalesce(x[role], F.lit(""))).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    names = sorted({f for _, fs in layout.fields for f in fs})
    row = F.from_json(record, ",".join(f"`{n}` string" for n in names), _ANY_LENGTH)
    turns = []
    for role, fields in layout.fields:
        parts = F.filter(F.array(*[F.coalesce(row[f], F.lit("")) for f in fields]), lambda x: x != "") if len(fields) > 1 else None
        text = F.array_join(parts, "\n\n") if parts is not None else F.coalesce(row[fields[0]], F.lit(""))
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def canonical(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with layout and turns, by the fingerprint of each record."""
    record = F.col(column)
    out = records.drop("layout", "turns", "__print").withColumn("__print", fingerprint(record))
    layout, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for own in LAYOUTS:
        is_own = F.col("__print") == F.xxhash64(F.lit(_shape(own.paths)))
        layout = F.when(is_own, F.lit(own.name)).otherwise(layout)
        turns = F.when(is_own, _read(own, record).cast(_TURNS)).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": F.coalesce(turns, F.array().cast(_TURNS))}).drop("__print")


def escape(s: Column) -> Column:
    return F.regexp_replace(s, rf"([<\[])(\\*)({_CONTROL})", r"$1$2\\$3")


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, rf"([<\[])\\(\\*)({_CONTROL})", r"$1$2$3")


def apply_template(canon: DataFrame) -> DataFrame:
    """``canon`` (with turns) with formatted, and mask: spans [start, end) in code points of the
    assistant's texts."""
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("learn"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")
        ),
    )
    out = canon.drop("formatted", "mask", "__parts", "__at").withColumn("__parts", parts)
    sizes = F.transform("__parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long"))
    out = out.withColumn("__at", prefix_sums(sizes))
    formatted = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    spans = F.zip_with(
        "__parts",
        "__at",
        lambda p, at: F.struct(p["learn"].alias("learn"), (at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("end")),
    )
    mask = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return out.withColumns({"formatted": formatted, "mask": mask}).drop("__parts", "__at")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substr(F.split_part(p, F.lit(TEXT), F.lit(1)), F.lit(len(TURN) + 1))).alias("role"), unescape(F.split_part(p, F.lit(TEXT), F.lit(2))).alias("text")
        ),
    )


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def to_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation as JSON, in one of the layouts that can hold it.

    Conversations of a user and an assistant turn go to prompt layouts, others to lists of
    messages; which, their id decides."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    pick = F.coalesce(F.pmod(F.col("conv_id"), F.lit(3)), F.lit(0))
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.col("t")[1]["role"] == "assistant")
    two = lambda a, b: F.to_json(F.struct(F.col("t")[0]["text"].alias(a), F.col("t")[1]["text"].alias(b)))
    many = lambda top, a, b: F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias(a), x["text"].alias(b))).alias(top)))
    known = F.exists("t", lambda x: x["role"].isin(*ROLES))  # such a role would be renamed on the way
    record = (
        F.when(pair & (pick == 0), two("prompt", "response"))
        .when(pair & (pick == 1), two("instruction", "output"))
        .when((pick == 2) & ~known, many("conversations", "from", "value"))
        .otherwise(many("messages", "role", "content"))
    )
    return grouped.select("conv_id", record.alias("record"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7, 0, 'user', '{says}'), (-7, 1, 'assistant', '{says}') AS t(conv_id, turn, role, text)")
    more = more.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema])
    done = apply_template(canonical(to_records(rows.unionByName(more)))).select("conv_id", "formatted", "mask")
    back = done.select("conv_id", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\2\\\3', 'g'))
          + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\2\\\3', 'g')) + 23 AS n FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS l, sum(n) AS f
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars,
       sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars
FROM g
"""
