"""Chat formatting by schema fingerprints, in DataFrame operations alone.

A record's layout is the set of its nested field paths, as far as any layout
names them; its fingerprint is the hash of the sorted paths. A registry maps
fingerprints to declarative mappings (SQL expressions over the record's fields),
which bring prompt, instruction and message layouts into one form: rows of
(conversation, position, role, text). Records are JSON, or rows whose columns are
the fields, null where a record lacks one: then the fingerprint is that of the
row's filled columns, so that records of several layouts share a table, and no
value goes through JSON. The rows are written with a template that marks turns and escapes
control strings so that the texts can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import pick, text_or_empty


@dataclass(frozen=True)
class Layout:
    """Field paths, and an SQL expression for ``array<struct<role string, text string>>`` in which ``{field}`` and
    ``{field:type}`` stand for a field of the record."""

    name: str
    paths: tuple[str, ...]
    turns: str

    def over(self, get) -> Column:
        """The turns, where ``get(field, type)`` gives the SQL of a field."""
        return F.expr(re.sub(r"\{(\w+)(?::([^}]+))?\}", lambda m: get(m[1], m[2] or "string"), self.turns))


def _pair(first: str, second: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {first}), named_struct('role', 'assistant', 'text', {second}))"


def _list(field: str, role: str, text: str) -> str:
    kind = f"array<struct<{role} string, {text} string>>"
    return f"transform({{{field}:{kind}}}, x -> named_struct('role', cast(x.{role} as string), 'text', cast(x.{text} as string)))"


#: The layouts that are known from the start. ``paths`` have no array marks and no types; a list without entries has
#: only its own path.
LAYOUTS = (
    Layout("turn row", ("role", "text"), "array(named_struct('role', {role}, 'text', {text}))"),
    Layout("prompt", ("completion", "prompt"), _pair("{prompt}", "{completion}")),
    Layout("prompt response", ("prompt", "response"), _pair("{prompt}", "{response}")),
    Layout("instruction", ("instruction", "output"), _pair("{instruction}", "{output}")),
    Layout("instruction input", ("input", "instruction", "output"), _pair("concat_ws('\\n', {instruction}, nullif({input}, ''))", "{output}")),
    Layout("messages", ("messages", "messages.content", "messages.role"), _list("messages", "role", "content")),
    Layout("no messages", ("messages",), _list("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations.from", "conversations.value"), _list("conversations", "from", "value")),
    Layout("no conversations", ("conversations",), _list("conversations", "from", "value")),
)
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def common_role(role: Column) -> Column:
    return reduce(lambda c, x: F.when(role == x[0], F.lit(x[1])).otherwise(c), ROLES.items(), role)


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def field_paths(v: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Sorted field paths of a variant that some layout names; other fields, at any depth, do not matter.

    A nested path is looked up in an object and in the first object of a list.
    """

    def there(path: str) -> Column:
        outer, _, inner = path.partition(".")
        at = [f"$.{outer}.{inner}", f"$.{outer}[0].{inner}"] if inner else [f"$.{outer}"]
        return F.coalesce(*[F.when(F.try_variant_get(v, p, "variant").isNotNull(), F.lit(path)) for p in at])

    return F.array_compact(F.array(*[there(p) for p in known_paths(layouts)]))


def schema_paths(schema: StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    """The same of a table whose columns are the fields."""

    def below(kind: DataType, at: str) -> list[str]:
        inner = kind.elementType if isinstance(kind, ArrayType) else kind
        return [at, *[p for f in inner.fields for p in below(f.dataType, f"{at}.{f.name}")]] if isinstance(inner, StructType) else [at]

    return sorted({p for f in schema.fields for p in below(f.dataType, f.name)} & set(known_paths(layouts)))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _selected(rows: DataFrame, print_: Column, layouts: tuple[Layout, ...], get) -> DataFrame:
    """(conv_id, turn, place, role, text, layout) by the mapping that the fingerprint selects."""
    known = [(layout, fingerprint(F.array(*[F.lit(p) for p in sorted(layout.paths)]))) for layout in layouts]
    turns = reduce(lambda other, k: F.when(print_ == k[1], k[0].over(get)).otherwise(other), reversed(known), F.expr("cast(null as array<struct<role: string, text: string>>)"))
    name = reduce(lambda other, k: F.when(print_ == k[1], F.lit(k[0].name)).otherwise(other), reversed(known), F.lit(None).cast("string"))
    rows = rows.select("conv_id", "turn", name.alias("layout"), turns.alias("turns")).filter("turns is null or size(turns) > 0")
    rows = rows.select("conv_id", "turn", "layout", F.posexplode_outer("turns").alias("place", "t"))
    return rows.select("conv_id", "turn", "place", common_role(F.col("t.role")).alias("role"), F.col("t.text").alias("text"), "layout")


def canonical_turns(df: DataFrame, record_col: str = "record", id_col: str = "conv_id", order_col: str = "turn", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, place, role, text, layout) of JSON records, a row for each turn.

    A record that is no JSON object, is beyond the parser's limit or has an unknown layout gives one row with null
    layout, role and text, which :func:`format_turns` refuses. A list without entries gives no row.
    ``turn`` is the record's place in its conversation; ``place`` the turn's place in the record.
    """
    base = pick(df, conv_id=id_col, turn=order_col, record=record_col).withColumn("v", F.try_parse_json("record"))
    base = base.withColumn("print", fingerprint(field_paths(F.col("v"), layouts)))
    return _selected(base, F.col("print"), layouts, lambda field, kind: f"try_variant_get(v, '$.{field}', '{kind}')")


def filled_paths(columns: dict[str, Column], paths: list[str]) -> Column:
    """Which of ``paths`` a row fills: a column that is not null, a field of a list's structs where the list has entries."""
    there = lambda p: (columns[p].isNotNull() if "." not in p else F.coalesce(F.size(columns[p.partition(".")[0]]) > 0, F.lit(False)))
    return F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in paths]))


def turns_of_columns(df: DataFrame, id_col: str, order_col: str, fields: dict[str, str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """As :func:`canonical_turns` of rows whose columns are the fields (``fields``: field to column), lists being arrays of
    structs. Each row has the fingerprint of its filled columns, which selects its mapping; no value goes through JSON.
    A row that fills the fields of no layout has a null layout; columns that no layout can come of raise ValueError."""
    base = pick(df, conv_id=id_col, turn=order_col, **{f"f_{f}": c for f, c in fields.items()})
    paths = schema_paths(StructType([base.schema[f"f_{f}"].__class__(f, base.schema[f"f_{f}"].dataType) for f in fields]), layouts)
    usable = tuple(x for x in layouts if set(x.paths) <= set(paths))
    if not usable:
        raise ValueError(f"no layout has the fields {', '.join(paths) or 'of this table'}")
    print_ = fingerprint(filled_paths({f: F.col(f"f_{f}") for f in fields}, paths))
    return _selected(base, print_, usable, lambda field, kind: f"f_{field}" if kind.startswith("array") else f"cast(f_{field} as {kind})")


#: The template's marks: a turn is OPEN role CLOSE text END. Every control string of it and of common chat
#: formats has a "<" or a "[", which texts and roles never have once they are escaped.
OPEN, CLOSE, END = "<|turn|>", "<|text|>", "</s>\n"
#: Characters and what stands for them in texts; "&" comes first when escaping and last when reading back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): one row per conversation; the mask has a (start, length) pair in code
    points of ``formatted`` for each assistant text.

    ``turns`` has conv_id, turn, place, role, text. Turns stand in order of turn, place, role and text; null
    roles and texts count as empty; a null conversation id is one conversation. Where ``turns`` has the column layout
    and it is null, the record is of no known layout: that raises, since its texts would be lost.
    """
    if "layout" in turns.columns:
        lost = F.raise_error(F.concat(F.lit("a record of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(" has no known layout")))
        turns = turns.withColumn("role", F.when(F.col("layout").isNull(), lost.cast("string")).otherwise(F.col("role")))
    rows = turns.select("conv_id", "turn", "place", escape(text_or_empty("role")).alias("role"), escape(text_or_empty("text")).alias("text"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(CLOSE))
    rows = rows.withColumn("head", F.length(head)).withColumn("whole", F.concat(head, F.col("text"), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "place", "role", "text")
    rows = rows.withColumn("at", F.sum(F.length("whole")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("whole"))
    rows = rows.withColumn("n", F.row_number().over(order))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("head")).alias("start"), F.length("text").cast("long").alias("length")))
    each = F.sort_array(F.collect_list(F.struct("n", "whole", span.alias("span"))))
    out = rows.groupBy("conv_id").agg(each.alias("e"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("e", lambda x: x["whole"]), "").alias("formatted"),
        F.filter(F.transform("e", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, F.lit("</s>\\n"), -1), lambda x: x.startswith(OPEN))
    body = lambda x: F.substr(x, F.lit(len(OPEN) + 1))
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring_index(body(x), CLOSE, 1)).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, CLOSE, 1)) + len(CLOSE) + 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def chat_digest(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", messages_col: str | None = None) -> DataFrame:
    """Formats conversations and digests what is read back from the output.

    Rows are turns, or with ``messages_col`` (array of structs role, content) whole conversations where that is not
    null; each row's fingerprint selects its mapping. One row per conversation: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. A turn's null role or text counts as empty. Turns with the same number stand in
    order of role and text. An empty table gives no rows.
    """
    more = {} if messages_col is None else {"messages": messages_col}
    rows = pick(df, conv_id=id_col, turn=turn_col, role=role_col, text=text_col, **more)
    turn = F.lit(True) if messages_col is None else F.col("messages").isNull()
    rows = rows.select(F.col("conv_id").cast("long"), "turn", *[F.when(turn, text_or_empty(c)).alias(c) for c in ("role", "text")], *more)
    out = format_turns(turns_of_columns(rows, "conv_id", "turn", {c: c for c in ("role", "text", *more)}))
    out = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
