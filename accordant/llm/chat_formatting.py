"""Chat formatting by schema fingerprints.

Nested field paths are hashed to a fingerprint, which selects a declarative
mapping from a layout (prompt and completion, instruction with input, message
lists, rows by turn) to canonical turns of role and text.  A layout's fingerprint
is that of the paths it needs; a record or a table has the layout if those of its
paths that the layout names hash to it, and of several the one that needs most
paths holds, so that further fields, nested ones too, cost no turns.  A table's
paths are those of its schema, a JSON record's those of its keys.

Turns are then written with a template that marks them by control strings; a
control string inside a text is escaped, so that the text can be read back
exactly, and a loss mask holds the spans of the assistant's texts.  Only DataFrame
functions are used.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  In a text, every
``<|`` becomes ``<||``; so ``<|`` followed by a letter is a control string, and
taking one bar away after each ``<|`` gives the text back.  In a role, ``%`` and
the line end are escaped as well.

Defined results for odd input: a null text or role is an empty one; turns with
equal numbers go by role, then text, and null numbers come first; repeated rows
are turns of their own; a null conversation id is a conversation; a content that is
a list of parts is the texts of its parts in order; JSON records of an unknown
layout, or no JSON at all, have null turns, and a table of an unknown layout is an
error; an empty table gives an empty result; further columns are ignored, and one
named like a column that is added gives way to it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where turns are: rows of their own, a list field with a role and a text path in each item, or single fields with fixed roles."""

    name: str
    paths: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashed(self.paths)


def hashed(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _list(name: str, items: str, role: str, text: str) -> Layout:
    return Layout(name, (items, f"{items}.{role}", f"{items}.{text}"), items, role, text)


def _single(name: str, *fields: tuple[str, tuple[str, ...]]) -> Layout:
    return Layout(name, tuple(p for _, ps in fields for p in ps), fields=fields)


# The layouts that are known, and other names of roles.
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), role="role", text="text"),
    _list("messages", "messages", "role", "content"),
    _list("speakers", "conversations", "from", "value"),
    _list("dialogue", "dialogue", "speaker", "text"),
    _single("instruction", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _single("instruction_only", ("user", ("instruction",)), ("assistant", ("output",))),
    _single("instruction_system", ("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    _single("prompt_completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _single("prompt_response", ("user", ("prompt",)), ("assistant", ("response",))),
    _single("question_answer", ("user", ("question",)), ("assistant", ("answer",))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def by_need(layouts: tuple[Layout, ...]) -> list[Layout]:
    return sorted(layouts, key=lambda x: -len(x.paths))


def schema_paths(schema: T.StructType, above: str = "") -> list[str]:
    """Nested field paths of a table, lists and maps passed through."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{above}{f.name}"
        out.append(path)
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, f"{path}.")
    return out


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout that a table's fingerprint selects."""
    paths = set(schema_paths(schema))
    for x in by_need(layouts):
        if hashed(paths & set(x.paths)) == x.fingerprint:
            return x
    raise ValueError(f"no mapping for a table with the fields {sorted(paths)}")


def known_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, role), role, F.lit(""))


def joined(texts: list[Column]) -> Column:
    """Texts that are not empty, a line end between them."""
    return F.array_join(F.filter(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), lambda t: t != ""), "\n")


def canonical_rows(table: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text from a table of any known layout, which its schema's fingerprint selects."""
    x, who = layout_of(table.schema, layouts), F.col(id_col).alias("conv_id")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if x.items:
        table = table.select(who, F.posexplode(x.items).alias("turn", "item"))
        return table.select("conv_id", F.col("turn").cast("long").alias("turn"), known_role(F.col(f"item.{x.role}").cast("string")).alias("role"), text(F.col(f"item.{x.text}")).alias("text"))
    if x.fields:
        parts = F.array(*[F.struct(F.lit(role).alias("role"), joined([F.col(p).cast("string") for p in ps]).alias("text")) for role, ps in x.fields])
        table = table.select(who, F.posexplode(parts).alias("turn", "item"))
        return table.select("conv_id", F.col("turn").cast("long").alias("turn"), "item.role", "item.text")
    return table.select(who, "turn", text(F.col(x.role)).alias("role"), text(F.col(x.text)).alias("text"))  # roles as they stand


def record_paths(value: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Paths of a JSON record (variant): its keys, and those of the items of its lists that layouts know."""
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    out = [keys(F.try_variant_get(value, "$", "map<string,variant>"))]
    for items in dict.fromkeys(x.items for x in layouts if x.items):
        inner = F.flatten(F.transform(F.try_variant_get(value, f"$.{items}", "array<variant>"), lambda m: keys(F.try_variant_get(m, "$", "map<string,variant>"))))
        out.append(F.coalesce(F.transform(inner, lambda k: F.concat(F.lit(f"{items}."), k)), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*out)))


def canonical_turns(records: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The table with record_fingerprint, layout (null: unknown) and turns."""
    value = F.try_parse_json(F.col(json_col).cast("string"))

    def get(v: Column, path: str) -> Column:
        """A text, or the texts of a list of parts, which are texts or have one in their field text."""
        parts = F.try_variant_get(v, path, "array<variant>")
        texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit("")))
        return F.coalesce(F.array_join(texts, ""), F.try_variant_get(v, path, "string"), F.lit(""))

    def turns(x: Layout) -> Column:
        if x.items:
            items = F.try_variant_get(value, f"$.{x.items}", "array<variant>")
            return F.transform(items, lambda m: F.struct(known_role(get(m, f"$.{x.role}")).alias("role"), get(m, f"$.{x.text}").alias("text")))
        return F.array(*[F.struct(F.lit(role).alias("role"), joined([get(value, f"$.{p}") for p in ps]).alias("text")) for role, ps in x.fields])

    layouts = tuple(x for x in layouts if x.items or x.fields)
    paths, layout, made = record_paths(value, layouts), F.when(F.lit(False), ""), F.when(F.lit(False), F.array().cast(TURNS))
    for x in by_need(layouts):
        named = F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in x.paths])))
        hit = F.sha2(F.array_join(named, "\n"), 256) == x.fingerprint
        layout, made = layout.when(hit, x.name), made.when(hit, turns(x))
    added = {"record_fingerprint": F.sha2(F.array_join(paths, "\n"), 256), "layout": layout, "turns": made}
    return records.withColumns(added)


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted_turn_rows(table: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, formatted, loss_mask (spans of code points) of each conversation of a table of any known layout."""
    turns = canonical_rows(table, id_col)
    part = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    placed = placed.withColumn("to", F.sum(F.length("part").cast("long")).over(order) - len(END))
    loss = F.when(F.col("role") == "assistant", F.struct("n", (F.col("to") - F.length(escaped(F.col("text")))).alias("start"), F.col("to").alias("end")))
    by_turn = F.array_sort(F.collect_list(F.struct("n", "part")))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(by_turn, lambda x: x["part"]), "").alias("formatted"),
        F.transform(F.array_sort(F.collect_list(loss)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_mask"),
    )


def formatted_turns(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """The table with formatted, from canonical turns in one column; null turns give null."""
    part = lambda t: F.concat(F.lit(START), escaped_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(END))
    return records.withColumn("formatted", F.array_join(F.transform(turns_col, part), ""))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.filter(F.split(formatted, START.replace("|", r"\|"), -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescaped_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescaped(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - len(END))).alias("text"),
    ))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask give when they are read back."""
    turns = formatted.withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
