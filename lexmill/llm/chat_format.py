"""Chat records of many layouts as canonical turns, and turns as training text with a loss mask.

Method: schema fingerprinting. A record's nested field paths (`messages[].role`) are hashed; the hashes select the
declarative mapping that says where the turns are: of the mappings whose paths a record has all of, the one with most
paths, the first listed of equals. Fields that no mapping names pass by. Typed tables are fingerprinted once from their
schema, JSON records each from its own parsed value; both go by the same hashes (XXH64, seed 42) and the same choice.
Known layouts are in `MAPPINGS`; more can be given. A JSON record without a layout says why in `rejected`, and
`rejects` counts such records by reason and fingerprint, so none is lost in silence.

The template writes a turn as `<|turn|>role`, a line feed, the text, `<|end|>` and a line feed. Inside roles and texts
every control string (of this template or of other common ones) gets a backslash behind its first character, and one
that already has backslashes there gets one more, so the way back is exact. Line feeds in roles are written as `\\n`.

How it runs. Built-in expressions only. Rows by turn are gathered by conversation with one shuffle; a conversation is
one output text, so its turns meet in one row by nature.

Defined results: null texts are empty; null roles are empty; turns of equal or null number are ordered by number
(nulls first), role and text. Records of an unknown layout, invalid JSON, JSON above the 16 MB that Spark's variant
holds, and null records have no turns, a null layout and their reason. A list whose elements are of different kinds at
a path that a mapping needs is an unknown layout. A null conversation id is a conversation like any other; repeated rows stay repeated turns. An empty table gives an
empty result. Columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import let

TURN, END = "<|turn|>", "<|end|>\n"
_ANGLE, _SQUARE = r"<(\\*)(/?s>|/?SYS>|\|)", r"\[(\\*)(/?INST\])"
#: Pieces of a variant's type: field names with their colon, openings, closings and scalar types.
_PIECES = r"`(?:[^`]|``)*`:|[^<>,:`\s]+:|OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]*\))?"
SEED = 42
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: a list of records with role and text fields, or (role, field) pairs in order."""

    layout: str
    paths: str
    list_field: str | None = None
    role_field: str = ""
    text_field: str = ""
    turns: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def needs(self) -> tuple[str, ...]:
        """The paths that a record must have."""
        if self.list_field:
            return tuple(f"{self.list_field}[].{name}" for name in (self.role_field, self.text_field))
        return tuple(name for _, name in self.turns)


def _record(*fields: str) -> str:
    return "{" + ",".join(sorted(fields)) + "}"


def _list(layout: str, field: str, role: str, text: str, roles: Sequence[tuple[str, str]] = ()) -> Mapping:
    return Mapping(layout, _record(f"{field}:[{_record(role + ':v', text + ':v')}]"), field, role, text, (), tuple(roles))


def _flat(layout: str, *turns: tuple[str, str]) -> Mapping:
    return Mapping(layout, _record(*(f"{name}:v" for _, name in turns)), turns=turns)


#: Layouts in common use.
MAPPINGS = (
    _list("messages", "messages", "role", "content"),
    _list("turns", "turns", "role", "text"),
    _list("exchange", "conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    _flat("prompt-response", ("user", "prompt"), ("assistant", "response")),
    _flat("prompt-completion", ("user", "prompt"), ("assistant", "completion")),
    _flat("question-answer", ("user", "question"), ("assistant", "answer")),
    _flat("instruction", ("user", "instruction"), ("assistant", "output")),
    _flat("instruction-input", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    _flat("system-prompt-response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
)


def paths_of_type(kind: T.DataType) -> str:
    """Nested field paths of a type: {a:v,b:[{c:v}]}, fields sorted, values without their types."""
    if isinstance(kind, T.StructType):
        return _record(*(f"{f.name}:{paths_of_type(f.dataType)}" for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return f"[{paths_of_type(kind.elementType)}]"
    return "v"


def leaves_of_type(kind: T.DataType, above: str = "") -> list[str]:
    """The paths of a type's scalar fields."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves_of_type(f.dataType, f"{above}.{f.name}" if above else f.name)]
    if isinstance(kind, T.ArrayType):
        return leaves_of_type(kind.elementType, f"{above}[]")
    return [above]


def leaves_of_json(variant: Column, known: Sequence[str]) -> Column:
    """Those of the known paths that a parsed JSON value has (of its merged element types where it has lists), nested to any depth."""
    pieces = F.regexp_extract_all(F.schema_of_variant(variant), F.lit(_PIECES), F.lit(0))
    texts, none = "array<string>", F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("")).cast(texts).alias("above"), F.lit("").alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        top, name = F.element_at(acc["above"], -1), F.regexp_replace(F.replace(F.regexp_replace(x, "^`|`?:$", ""), F.lit("``"), F.lit("`")), "^$", "")
        at = F.when(x.endswith(":"), F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))).when(x == "ARRAY<", F.concat(acc["at"], F.lit("[]"))).otherwise(acc["at"])
        above = F.when(x.endswith("<"), F.concat(acc["above"], F.array(at))).when(x == ">", F.slice(acc["above"], F.lit(1), F.greatest(F.size(acc["above"]) - 1, F.lit(1)))).otherwise(acc["above"])
        leaf = ~x.endswith(":") & ~x.endswith("<") & (x != ">") & (x != "VARIANT") & acc["at"].isin(*known)
        return F.struct(above.alias("above"), at.alias("at"), F.when(leaf, F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"]).alias("found"))

    return F.coalesce(F.array_sort(F.array_distinct(F.aggregate(pieces, start, step)["found"])), none)


def path_hash(path: str) -> int:
    """The hash of a path, as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(path.encode(), SEED)
    return h - 2**64 if h >= 2**63 else h


def by_choice(mappings: Sequence[Mapping]) -> list[Mapping]:
    """Mappings in the order in which they are tried."""
    return sorted(mappings, key=lambda m: -len(m.needs))


def _turns(mapping: Mapping, get) -> Column:
    """Turns by a mapping; get(path, type) reads a field of the record."""
    if mapping.list_field:
        rows = get(mapping.list_field, f"array<struct<`{mapping.role_field}`:string,`{mapping.text_field}`:string>>")

        def one(x: Column) -> Column:
            role = x[mapping.role_field]
            for old, new in mapping.roles:
                role = F.when(role == old, new).otherwise(role)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(x[mapping.text_field], F.lit("")).alias("text"))

        return F.transform(F.coalesce(rows, F.array().cast(f"array<struct<`{mapping.role_field}`:string,`{mapping.text_field}`:string>>")), one)
    return F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(get(name, "string"), F.lit("")).alias("text")) for role, name in mapping.turns))


def from_typed(record: str, kind: T.StructType, mappings: Sequence[Mapping] = MAPPINGS) -> tuple[Column, Column]:
    """(layout, turns) of a struct column of the given type."""
    has = {path_hash(p) for p in leaves_of_type(kind)}
    for m in by_choice(mappings):
        if has.issuperset(map(path_hash, m.needs)):
            return F.lit(m.layout), _turns(m, lambda name, t: F.transform(F.col(record)[name], lambda x: F.struct(*(x[k].cast("string").alias(k) for k in (m.role_field, m.text_field)))) if m.list_field else F.col(record)[name].cast(t))
    return F.lit(None).cast("string"), F.array().cast(_TURNS)


def from_json(df: DataFrame, json_col: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Adds fingerprint, layout, turns and rejected (a reason, or null) of a JSON column, each row by its own layout."""
    known = sorted({p for m in mappings for p in m.needs})
    df = let(df, _value=F.try_parse_json(F.col(json_col)))
    df = let(df, _paths=F.transform(leaves_of_json(F.col("_value"), known), lambda p: F.xxhash64(p)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for m in reversed(by_choice(mappings)):
        own = F.size(F.array_except(F.array(*(F.lit(path_hash(p)) for p in m.needs)), "_paths")) == 0
        layout = F.when(own, F.lit(m.layout)).otherwise(layout)
        turns = F.when(own, _turns(m, lambda name, t: F.try_variant_get("_value", f"$.{name}", t))).otherwise(turns)
    rejected = F.when(F.col(json_col).isNull(), "null record").when(F.col("_value").isNull(), "unreadable").when(layout.isNull(), "unknown layout")
    return df.withColumns({"fingerprint": F.xxhash64("_paths"), "layout": layout, "turns": turns, "rejected": rejected}).drop("_value", "_paths")


def rejects(records: DataFrame) -> DataFrame:
    """(rejected, fingerprint, n): records of `from_json` that have no layout, by reason and known paths."""
    return records.where("rejected IS NOT NULL").groupBy("rejected", "fingerprint").agg(F.count("*").alias("n"))


def as_json(records: DataFrame, record_col: str = "record") -> Column:
    """JSON of a record of the layout {turns:[{role,text}]} in the layout that people would give it.

    One question and its answer are {prompt,response}, with {system} if a system turn stands before, all else is
    {messages:[{role,content}]}. Null where the texts are too long for a JSON value to be parsed again.
    """
    turns = F.col(record_col)["turns"]
    roles, text = F.transform(turns, lambda t: t["role"]), lambda k: F.get(turns, F.lit(k))["text"]
    pair = F.to_json(F.struct(F.size(turns).alias("n"), text(0).alias("prompt"), text(1).alias("response")))
    led = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    messages = F.to_json(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    size = F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["role"]) + F.octet_length(t["text"]) + 32)
    same = lambda *names: roles == F.array(*map(F.lit, names))
    # a character takes six bytes at most as JSON, a variant 16 MB
    return F.when(size * 6 < 16 << 20, F.when(same("user", "assistant"), pair).when(same("system", "user", "assistant"), led).otherwise(messages))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, r"<\\$1$2"), _SQUARE, r"[\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)(/?s>|/?SYS>|\|)", "<$1$2"), r"\[\\(\\*)(/?INST\])", "[$1$2")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # every backslash is doubled or before an n: doubled ones become \\b first, so that an n behind them isn't taken for a line feed
    doubled = F.replace(role, F.lit("\\\\"), F.lit("\\b"))
    return unescape(F.replace(F.replace(doubled, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def formatted(turns: Column) -> Column:
    """The training text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))), "")


def read_back(text: Column) -> Column:
    """Canonical turns of a training text."""
    parts = F.filter(F.split(text, re.escape(TURN)), lambda p: p != "")

    def one(part: Column) -> Column:
        cut = F.instr(part, "\n")
        body = F.substring(part, cut + 1, F.length(part) - cut - len(END))
        return F.struct(_unescape_role(F.substring(part, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, one)


def loss_spans(text: Column, learned: str = "assistant") -> Column:
    """(start, stop) code points of the formatted text that count for the loss: bodies of the learned role's turns."""
    parts = F.filter(F.split(text, re.escape(TURN)), lambda p: p != "")
    ends = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + len(TURN) + F.length(p)).alias("at"),
            F.when(
                _unescape_role(F.substring(p, F.lit(1), F.instr(p, "\n") - 1)) == learned,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(TURN) + F.instr(p, "\n")).alias("start"), (acc["at"] + len(TURN) + F.length(p) - len(END)).alias("stop")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return ends["spans"]


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["stop"] - s["start"]))), "")


def gather(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): rows by turn as one record of the layout {turns:[{role,text}]}."""
    none = F.lit("")
    each = rows.select(F.col(id_col).alias(id_col), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), none).alias("role"), F.coalesce(F.col(text_col).cast("string"), none).alias("text")).alias("t"))
    all_ = each.groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("t"))
    return all_.select(id_col, F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).alias("record"))


def _with_text(records: DataFrame) -> DataFrame:
    out = let(records, formatted=formatted(F.col("turns")))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted")))


def format_records(records: DataFrame, record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Typed records with columns layout, turns, formatted and loss_spans added."""
    layout, turns = from_typed(record_col, records.schema[record_col].dataType, mappings)
    return _with_text(records.withColumns({"layout": layout, "turns": turns}))


def format_json(records: DataFrame, json_col: str, mappings: Sequence[Mapping] = MAPPINGS, record_col: str | None = None) -> DataFrame:
    """JSON records with columns fingerprint, layout, turns, rejected, formatted and loss_spans added.

    Where the JSON is null and a column of typed records is named, the record's layout and turns are taken.
    """
    found = from_json(records, json_col, mappings)
    if record_col:
        layout, turns = from_typed(record_col, records.schema[record_col].dataType, mappings)
        typed = F.col(json_col).isNull() & F.col(record_col).isNotNull() & layout.isNotNull()
        found = found.withColumns({"layout": F.when(typed, layout).otherwise(F.col("layout")), "turns": F.when(typed, turns).otherwise(F.col("turns")), "rejected": F.when(~typed, F.col("rejected"))})
    return _with_text(found)
