"""Chat formatting: records of many layouts become canonical turns and one training text.

A record is a struct column as Spark reads it from JSON lines of mixed layouts: all fields of
all layouts, null where a record has none. The nested paths that a record fills are hashed,
and the hash selects the declarative mapping that makes turns of it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, HEAD_END, END = "### ", ":\n", "</turn>\n"
#: Characters that get a backslash before them, so that no mark can occur inside a text.
IN_TEXT = r"\\|#|(?<=<)/(?=turn>)"
IN_ROLE = IN_TEXT + r"|\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How the turns of a record lie in its fields.

    ``turns`` names a role and the fields whose texts make up that turn, joined by a blank
    line; fields in ``optional`` may be missing and so may the turn. ``messages`` is instead
    the path of an array with the fields ``role`` and ``text``; ``roles`` renames roles.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)

    def path_sets(self) -> list[list[str]]:
        """Every set of nested paths that this layout may fill, sorted."""
        if self.messages:
            return [sorted(f"{self.messages}[].{x}" for x in (self.role, self.text))]
        needed = [f for _, fields in self.turns for f in fields if f not in self.optional]
        return [
            sorted([*needed, *some])
            for n in range(len(self.optional) + 1)
            for some in combinations(self.optional, n)
        ]


LAYOUTS = (
    Layout("prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
           optional=("system",)),
    Layout("completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", (("user", ("instruction", "input")), ("assistant", ("output",))),
           optional=("input",)),
    Layout("messages", messages="messages", role="role", text="content"),
    Layout("conversations", messages="conversations", role="from", text="value",
           roles={"human": "user", "gpt": "assistant"}),
)


def _column(record: str, path: str) -> Column:
    out = F.col(record)
    for part in path.split("."):
        out = out[part]
    return out


def _paths(kind: T.StructType, before: str = "") -> list[tuple[str, str]]:
    """``(path, path of the value that must not be null)`` of every leaf of a struct."""
    out: list[tuple[str, str]] = []
    for f in kind.fields:
        at = f"{before}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += _paths(f.dataType, f"{at}.")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += [(f"{at}[].{leaf}", at) for leaf, _ in _paths(f.dataType.elementType)]
        else:
            out.append((at, at))
    return out


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def fingerprint(df: DataFrame, record: str) -> Column:
    """Hash of the sorted nested paths that the record fills."""
    kind = df.schema[record].dataType
    filled = [
        F.when(_column(record, value).isNotNull(), F.lit(path))
        for path, value in sorted(_paths(kind))
    ]
    return _hash(F.array_compact(F.array(*filled)))


def _turns(df: DataFrame, record: str, layout: Layout) -> Column:
    if layout.messages:
        def one(m: Column) -> Column:
            role = F.coalesce(m[layout.role].cast("string"), F.lit(""))
            for old, new in layout.roles.items():
                role = F.when(role == old, new).otherwise(role)
            text = F.coalesce(m[layout.text].cast("string"), F.lit(""))
            return F.struct(role.alias("role"), text.alias("text"))

        return F.transform(F.array_compact(_column(record, layout.messages)), one)
    there = {path for path, _ in _paths(df.schema[record].dataType)}
    turns = []
    for role, fields in layout.turns:
        known = [_column(record, f) for f in fields if f in there]
        if known:
            text = F.concat_ws("\n\n", *known)
            turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
            turns.append(F.when(F.coalesce(*known).isNotNull(), turn))
    return F.array_compact(F.array(*turns)).cast(TURNS)


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns`` (role and text of each turn).

    A record whose fingerprint no layout has, a null one among them, gets null for both. Null
    roles and texts in messages become empty strings; null messages are left out.
    """
    there = {path for path, _ in _paths(df.schema[record].dataType)}
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    mark = fingerprint(df, record)
    for layout in layouts:
        known = [s for s in layout.path_sets() if set(s) <= there and s]
        if known:
            hashes = [_hash(F.array(*map(F.lit, s))) for s in known]
            hit = F.col("_fingerprint").isin(*hashes)
            name = F.when(hit, layout.name).otherwise(name)
            turns = F.when(hit, _turns(df, record, layout)).otherwise(turns)
    out = df.withColumn("_fingerprint", mark)
    return out.withColumn("layout", name).withColumn("turns", turns).drop("_fingerprint")


def escape(text: Column, marks: str = IN_TEXT) -> Column:
    return F.regexp_replace(text, marks, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns", learned: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``.

    Each turn is ``### role:``, a line end, the text and ``</turn>`` with a line end; backslash,
    ``#`` and the slash of ``</turn>`` inside a text get a backslash before them. A loss span
    has ``turn`` (from 0), ``start`` (code points from the start of that turn) and ``length``
    of a text of the role ``learned``. Null turns give a null ``formatted`` and no spans.
    """
    head = lambda t: F.concat(F.lit(HEAD), escape(t.role, IN_ROLE), F.lit(HEAD_END))
    parts = F.transform(
        F.col(turns),
        lambda t: F.struct(t.role.alias("role"), head(t).alias("head"), escape(t.text).alias("body")),
    )
    spans = F.transform(
        F.col("_parts"),
        lambda p, i: F.when(
            p.role == learned,
            F.struct(
                i.alias("turn"), F.char_length(p.head).alias("start"),
                F.char_length(p.body).alias("length"),
            ),
        ),
    )
    whole = F.transform(F.col("_parts"), lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    empty = F.array().cast("array<struct<turn:int,start:int,length:int>>")
    return (
        df.withColumn("_parts", parts)
        .withColumn("formatted", F.array_join(whole, ""))
        .withColumn("loss_spans", F.coalesce(F.array_compact(spans), empty))
        .drop("_parts")
    )


def read_formatted(df: DataFrame) -> DataFrame:
    """Adds ``read_turns`` (role and text of each turn) and ``loss_texts``, from the output alone."""
    pieces = F.filter(F.split("formatted", r"(?<=</turn>\n)", -1), lambda s: s != "")

    def one(s: Column) -> Column:
        at = F.instr(s, F.lit(HEAD_END))
        role = F.substr(s, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        start = at + len(HEAD_END)
        text = F.substr(s, start, F.char_length(s) - start - len(END) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def lost(m: Column) -> Column:
        return unescape(F.substr(F.col("_pieces")[m.turn], m.start + 1, m.length))

    none = F.array().cast("array<string>")
    return (
        df.withColumn("_pieces", F.coalesce(pieces, none))
        .withColumn("read_turns", F.transform("_pieces", one))
        .withColumn("loss_texts", F.transform("loss_spans", lost))
        .drop("_pieces")
    )


def format_records(
    df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS, learned: str = "assistant",
) -> DataFrame:
    """``canonical_turns`` and ``format_turns`` in one: adds layout, turns, formatted, loss_spans."""
    return format_turns(canonical_turns(df, record, layouts), learned=learned)


def conversation_records(rows: DataFrame) -> DataFrame:
    """One record per ``conv_id`` from rows ``conv_id, turn, role, text``, in the order of turns.

    A user and an assistant turn, with or without a system turn before them, make a record of
    the prompt layout, all else one of the message layout, so that both kinds meet in one
    column as in collections from several sources. Rows with the same turn are ordered by role
    and text; a null text is empty, a null id is an id of its own.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_all"))
    roles = F.array_join(F.transform("_all", lambda t: t.role), "\n")
    short = roles.isin("user\nassistant", "system\nuser\nassistant")
    text = lambda i: F.when(short, F.element_at("_all", F.lit(i)).content)
    system = F.when(short & (F.size("_all") == 3), F.element_at("_all", F.lit(1)).content)
    messages = F.transform("_all", lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
    record = F.struct(
        system.alias("system"), text(-2).alias("prompt"), text(-1).alias("response"),
        F.when(~short, messages).alias("messages"),
    )
    return grouped.select("conv_id", record.alias("record"))
